"""Known libraries and vendor folders."""

from __future__ import annotations

#: category | name | file patterns, in the order in which they are tried.
KNOWN = r"""
ui-framework | React | react(-dom)?\.  react\.(min\.)?js
ui-framework | Vue.js | vue(\.(min|esm|global))?\.js  vue@
ui-framework | Angular | angular(\.min)?\.js  @angular\/
ui-framework | Svelte | svelte(\.min)?\.js
ui-framework | Preact | preact(\.min)?\.js
ui-framework | Ember.js | ember(\.min)?\.js
ui-framework | Backbone.js | backbone(\.min)?\.js
utility | Lodash/Underscore | lodash  underscore
utility | Ramda | ramda(\.min)?\.js
utility | RxJS | rxjs  rx\.js
utility | Immutable.js | immutable(\.min)?\.js
dom-manipulation | jQuery/Zepto | jquery  zepto
animation | GSAP | gsap  TweenMax  TweenLite
animation | Anime.js | anime(\.min)?\.js
animation | Velocity.js | velocity(\.min)?\.js
animation | Motion | motion(\.min)?\.js  framer-motion
animation | Lottie | lottie
charting | Chart.js | chart\.js  chart(\.min)?\.js
charting | D3.js | d3\.  d3(\.min)?\.js
charting | Highcharts | highcharts
charting | ECharts | echarts
charting | Plotly | plotly
charting | ApexCharts | apexcharts
charting | Recharts | recharts
mapping | Leaflet | leaflet
mapping | Mapbox GL | mapbox
mapping | OpenLayers | openlayers  ol\.js
mapping | Google Maps | (?i)google.*maps
date-time | Moment.js | moment(\.min)?\.js  moment-with-locales
date-time | Day.js | dayjs  day\.js
date-time | date-fns | date-fns
date-time | Luxon | luxon
http-client | Axios | axios
http-client | SuperAgent | superagent
http-client | Ky | ky(\.min)?\.js
state-management | Redux | redux
state-management | MobX | mobx
state-management | Vuex | vuex
state-management | Pinia | pinia
state-management | Zustand | zustand
state-management | Recoil | recoil
state-management | Jotai | jotai
form-validation | Yup | yup(\.min)?\.js
form-validation | Joi | joi
form-validation | Zod | zod
form-validation | Validator.js | validator(\.min)?\.js
3d-graphics | Three.js | three(\.min)?\.js  three\.module\.js
3d-graphics | Babylon.js | babylon
3d-graphics | A-Frame | aframe
game-engine | Phaser | phaser
game-engine | PixiJS | pixi
game-engine | CreateJS | createjs  easeljs
game-engine | p5.js | p5(\.min)?\.js
pdf-viewer | PDF.js | pdf\.js  pdf\.worker  pdfjs-dist
pdf-viewer | ViewerJS | ViewerJS
pdf-viewer | WebODF | webodf
rich-text-editor | TinyMCE | tinymce
rich-text-editor | CKEditor | ckeditor
rich-text-editor | Quill | quill
rich-text-editor | Froala | froala
rich-text-editor | Draft.js | draft-js  draftjs
rich-text-editor | Slate | slate
rich-text-editor | Trix | trix
rich-text-editor | ProseMirror | prosemirror
rich-text-editor | Tiptap | tiptap
code-editor | Monaco Editor | monaco
code-editor | CodeMirror | codemirror
code-editor | Ace Editor | ace-builds  ace\.js  ace-editor
code-editor | Prism | prism\.js  prismjs
code-editor | Highlight.js | highlight\.js  hljs
code-editor | Shiki | shiki
video-player | Video.js | video\.js  video-js
video-player | Plyr | plyr
video-player | JW Player | jwplayer
video-player | MediaElement.js | mediaelement
video-player | HLS.js | hls\.js
video-player | DASH.js | dash\.js
video-player | Shaka Player | shaka-player
carousel | Swiper | swiper
carousel | Slick | slick
carousel | Owl Carousel | owl\.carousel  owlcarousel
carousel | Splide | splide
carousel | Glide.js | glide
carousel | Flickity | flickity
testing | Jest | jest
testing | Mocha | mocha
testing | Jasmine | jasmine
testing | Chai | chai
testing | Sinon | sinon
testing | Cypress | cypress
testing | Playwright | playwright
bundler | Webpack Runtime | webpack.*runtime  webpackBootstrap
bundler | Rollup | rollup
bundler | Parcel | parcel
polyfill | core-js | core-js  corejs
polyfill | regenerator-runtime | regenerator-runtime
polyfill | Babel Runtime | babel.*polyfill  @babel\/runtime
polyfill | Polyfills | polyfill\.io  (?i)polyfills?\.(min\.)?js
scorm | SCORM API | (?i)scorm.*api  (?i)scorm-again  (?i)SCORM.*wrapper
scorm | Pipwerks SCORM | (?i)pipwerks.*scorm
crypto | CryptoJS | crypto-js  cryptojs
crypto | node-forge | forge(\.min)?\.js
crypto | SJCL | sjcl
crypto | TweetNaCl | tweetnacl
crypto | bcrypt.js | bcrypt
compression | Pako | pako
compression | JSZip | jszip
compression | fflate | fflate
analytics | Google Analytics | (?i)google.*analytics  gtag\.js  ga\.js
analytics | Mixpanel | mixpanel
analytics | Amplitude | amplitude
analytics | Segment | segment
analytics | Hotjar | hotjar
social | Facebook SDK | (?i)facebook.*sdk  fb\.js
social | Twitter SDK | (?i)twitter.*sdk  widgets\.js
social | LinkedIn SDK | linkedin
payment | Stripe.js | stripe\.js  stripe-js
payment | PayPal SDK | (?i)paypal.*sdk  (?i)paypal.*checkout
payment | Braintree | braintree
database | SQL.js | sql\.js  sql-wasm
database | PouchDB | pouchdb
database | Dexie.js | dexie
database | localForage | localforage
database | idb | idb
websocket | Socket.io | socket\.io  socket-io
websocket | SockJS | sockjs
websocket | ws | ws\.js
other | uuid | uuid
other | nanoid | nanoid
other | marked | marked(\.min)?\.js
other | markdown-it | markdown-it
other | Showdown | showdown
other | Handlebars | handlebars
other | Mustache | mustache
other | EJS | ejs
other | Pug | pug
other | i18next | i18next
other | FormatJS | intl-messageformat
other | Numeral.js | numeral
other | Accounting.js | accounting
other | FileSaver.js | file-saver  FileSaver
other | SheetJS | xlsx  sheetjs
other | PapaParse | papaparse
other | SortableJS | sortablejs  Sortable
other | interact.js | interact\.js
other | Hammer.js | hammer\.js  hammerjs
other | Cropper.js | cropperjs  cropper\.js
other | Fabric.js | fabric\.js  fabric
other | Konva | konva
other | Paper.js | paper\.js  paper-core
other | Snap.svg | snap\.svg
other | SVG.js | svg\.js
other | Autosize | autosize
other | Cleave.js | cleave
other | Imask.js | imask
other | Inputmask | inputmask
other | Flatpickr | flatpickr
other | Pikaday | pikaday
other | Choices.js | choices\.js
other | Select2 | select2
other | Tom Select | tom-select  tom\.select
other | Dropzone.js | dropzone
other | Uppy | uppy
other | FilePond | filepond
other | LightGallery | lightgallery
other | Fancybox | fancybox
other | GLightbox | glightbox
other | PhotoSwipe | photoswipe
other | Masonry | masonry
other | Isotope | isotope
other | lazysizes | lazysizes
other | Lozad | lozad
other | AOS | aos
other | ScrollReveal | scrollreveal
other | Particles.js | particles\.js  tsparticles
other | Typed.js | typed\.js
other | CountUp.js | countup
other | Tippy.js | tippy
other | Popper.js | popper
other | Floating UI | floating-ui
other | Notification Libraries | toastr  notyf  sweetalert
other | Howler.js | howler
other | Tone.js | tone\.js
other | WaveSurfer.js | wavesurfer
""".strip().splitlines()

VENDOR_DIRS = """
node_modules bower_components vendor vendors third-party third_party thirdparty external externals lib libs assets/js/lib assets/js/libs assets/js/vendor assets/vendor static/lib static/libs static/vendor public/lib public/libs public/vendor wwwroot/lib packages .pnpm jspm_packages
""".split()
